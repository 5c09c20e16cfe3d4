"""Model coupling as deterministic micro-batches."""
