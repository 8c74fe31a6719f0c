"""palimpsest: versioning, auditing and merging of conversation archives as Spark tables."""
