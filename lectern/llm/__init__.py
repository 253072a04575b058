"""Operators for building training data: identification, fingerprints, deduplication, mixing, encoding."""
