"""Operators of a training-data pipeline: text dedup, filtering, tokens and packing."""
