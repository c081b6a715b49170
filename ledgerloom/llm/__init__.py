"""Training-data operators: deduplication, filtering, tokenising, formatting."""
