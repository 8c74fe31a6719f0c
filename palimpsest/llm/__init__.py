"""Training-data operators: quality, similarity, packing, token files, sharding, extraction, mixing, search, counting, dedup."""
