"""Operators for training-data pipelines: text quality, scoring, duplicates, extraction, tokens, archives."""
