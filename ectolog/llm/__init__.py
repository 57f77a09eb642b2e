"""Operators for large text corpora: deduplication, filters, scans and tokens.

Nothing else in the library imports this package.
"""
