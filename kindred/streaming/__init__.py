"""Structured Streaming forms: windowed request counts, latency histograms, scoring and drift of micro-batches."""
