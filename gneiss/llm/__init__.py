"""Operators for preparing training corpora.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
