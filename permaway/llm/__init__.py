"""Operators of a training-data pipeline: sharding, deduplication, classifiers, search, packing and tokens."""
