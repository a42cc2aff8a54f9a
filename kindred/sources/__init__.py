"""Readers and writers: pair, catalogue and judgment files, manifests, reports, the registry."""
