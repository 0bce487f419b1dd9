"""Operators for training-data pipelines (the numbered operators and their queries)."""
