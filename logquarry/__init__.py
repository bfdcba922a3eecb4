"""Diagnostic-bundle analytics expressed as Spark DataFrame jobs."""
