"""Tidemark: batch-to-warehouse operators as plain Spark DataFrame plans."""
