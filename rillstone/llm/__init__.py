"""Training-data operators: cleaning, filtering, deduplication and mixing of a text corpus."""
