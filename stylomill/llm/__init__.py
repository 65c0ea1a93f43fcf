"""Training-data operators: deduplication, tokenizing, mixing, scoring and storage of text corpora."""
