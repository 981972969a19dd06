"""Operators of a training-data pipeline: packing, mixing, filtering, deduplication and labelling."""
