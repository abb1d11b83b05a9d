"""Training-data operators: search, deduplication, scanning, scoring, tokenising and mixing."""
