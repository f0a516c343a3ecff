"""Training-data operators: quality, archives, privacy, deduplication, extraction, packing.

Nothing outside this subpackage imports it.
"""
