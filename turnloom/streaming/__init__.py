"""The row-local and per-batch jobs over file streams."""
