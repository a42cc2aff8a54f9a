"""Relational operators over pair, catalogue and judgment tables."""
