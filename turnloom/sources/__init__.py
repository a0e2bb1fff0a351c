"""Reading datasets and writing JSON lines."""
