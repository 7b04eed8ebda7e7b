"""Operators of a training-data pipeline: packing, near-duplicate removal, mixing, classifiers, archives, search."""
