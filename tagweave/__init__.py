"""Keyword co-occurrence graphs as Spark DataFrame jobs."""
