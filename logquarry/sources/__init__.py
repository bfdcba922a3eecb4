"""Readers and writers for archives and parsed tables."""
