"""Training-data operators: scoring, filtering, near-duplicates, PII, search, sharding, packing, tokens."""
