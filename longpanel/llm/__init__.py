"""Operators for large text corpora: tokenising, filtering, deduplication, search, scoring.

Nothing else in the library imports this subpackage.
"""
