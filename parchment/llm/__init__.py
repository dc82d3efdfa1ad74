"""Training-data operators: deduplication, classification, filtering, mixing, tokenising and search."""
