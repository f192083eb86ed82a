"""Operators of training-data pipelines: clean-up, dedup, tokens, formats and checks of text corpora."""
