"""Training-data operators: tokenisation, near-duplicates, privacy, quality, packing.

Nothing outside this subpackage imports it.
"""
