"""Training-data operators: dedup, tokenising, filtering, scoring and sharding of text corpora."""
