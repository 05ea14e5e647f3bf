"""Operators for training-data preparation. Nothing outside this package imports it."""
