"""Training-data operators: quality, deduplication, extraction, tokenising and filters."""
