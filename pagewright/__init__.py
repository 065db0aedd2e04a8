"""Spark-first engine for text-quality work on large page collections."""
