"""Training-data operators: tokens, mixing, quality, language, near-duplicates, packing."""
