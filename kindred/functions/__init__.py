"""Column expressions: text normalisation, pair features, statistics."""
