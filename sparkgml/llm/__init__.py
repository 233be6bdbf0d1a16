"""Operators of a training-data pipeline: quality, packing, deduplication, language, toxicity, tokens."""
