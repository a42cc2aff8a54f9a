"""Queries over whole tables, protocol checks and release gates."""
