"""Operators for language-model training data: scoring, filtering, near duplicates, packing, search."""
