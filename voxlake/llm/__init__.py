"""Training-data operators: tokenising, filtering, deduplication, scoring and formatting of text corpora."""
