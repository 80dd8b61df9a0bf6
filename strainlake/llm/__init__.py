"""Training-data operators: quality, mixing, deduplication, toxicity, LM scores, packing, secrets, token files."""
