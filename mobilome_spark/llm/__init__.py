"""Training-data operators: deduplication, scoring, search, mixing, packing and record formats."""
