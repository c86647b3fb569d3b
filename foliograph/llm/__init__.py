"""Training-data operators: filtering, deduplication, mixing, tokenising and fingerprinting of text and media."""
