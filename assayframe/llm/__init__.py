"""Operators of a large training-data pipeline: cleaning, near copies, scoring, sharding, encoding."""
