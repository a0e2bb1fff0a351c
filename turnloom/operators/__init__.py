"""DataFrame operators: filters, records, masks, trajectories and scoring."""
