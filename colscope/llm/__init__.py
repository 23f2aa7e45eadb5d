"""Operators for training-data pipelines: search, dedup, scoring, sharding, mixing, token ids and counts."""
