"""Training-data operators: extraction, scoring, deduplication, packing.

Nothing outside this subpackage imports it.
"""
