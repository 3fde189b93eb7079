"""Operators for text corpora: filters, deduplication, packing, encoding, scoring, media, search.

Nothing outside this subpackage imports it.
"""
