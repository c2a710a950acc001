"""Operators for preparing large text corpora: filters, deduplication, mixing, encoding and vector search.

Nothing else in the library imports this subpackage.
"""
