"""Operators for preparing large text corpora: media, packing, archives, duplicates, mixing, filters.

Nothing outside this package imports it.
"""
