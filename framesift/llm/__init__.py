"""Operators of a training-data pipeline: deduplication, mixing, cleaning, scoring, tokenising."""
