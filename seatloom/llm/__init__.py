"""Training-data operators: filtering, deduplication, media, archives, tokenising and packing.

Nothing else in the library imports this subpackage.
"""
