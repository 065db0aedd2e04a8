"""Operators that prepare training text.

Nothing outside this folder imports it, apart from the guarded lookup in
``__spark_entry__`` and the corpus pipeline.
"""
