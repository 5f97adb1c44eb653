"""Training-data operators: mixing, packing, quality rules, near-duplicates, extraction, sharding.

Nothing else in the library imports this subpackage.
"""
