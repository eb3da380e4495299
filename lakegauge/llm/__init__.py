"""Operators of a training-data pipeline: near-duplicates, classifiers, mixing, extraction, archives, token files."""
