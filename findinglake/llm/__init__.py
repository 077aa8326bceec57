"""Training-data operators: deduplication, tokenisation, scoring, filtering, sharding and packing.

Nothing else in the library imports this subpackage.
"""
