"""Benthos: ecotoxicity evidence analytics expressed as Spark DataFrame jobs."""
