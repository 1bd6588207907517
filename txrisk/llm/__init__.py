"""Operators for preparing training text: quality, tokens, duplicates, leaks, archives, scores.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries
only where it is installed.
"""
