"""Operators of a training-data pipeline: sketches, deduplication, rules, models and packing of documents."""
