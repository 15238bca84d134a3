"""Operators for large text corpora: scoring, filtering, near-duplicates, mixing, packing, sharding and archives."""
