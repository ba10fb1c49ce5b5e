"""Training-data operators: tokenizing, filtering, scoring and deduplicating text corpora."""
