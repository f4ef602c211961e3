"""Operators for training data: clustering, selection, duplicates, neighbours, counts, tokens, leaks, normal form."""
