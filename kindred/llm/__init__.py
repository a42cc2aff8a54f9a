"""Operators for training data: similar vectors, near-duplicates, grouped splits, packing, mixing, personal data."""
