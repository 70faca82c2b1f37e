"""Operators for preparing text training data: tokens, quality, duplicates, contamination, packing."""
