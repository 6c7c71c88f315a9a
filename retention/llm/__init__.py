"""Operators for preparing training text at scale (deduplication, mixing, scoring, extraction).

Nothing outside this package and ``corpus_pipeline.py`` imports it."""
