"""Operators for large text corpora and their queries. Nothing outside this folder imports it."""
