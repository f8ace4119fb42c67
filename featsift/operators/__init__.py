"""Operators over the long matrix and its fitted tables (all Spark DataFrame jobs)."""
