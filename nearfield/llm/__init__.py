"""Training-data operators: tokenizing, filtering, near-duplicates, search, media and packing."""
