"""Training-data operators: filtering, deduplication, extraction and mixing of text corpora."""
