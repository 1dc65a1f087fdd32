"""Operators for building training data: cleaning, deduplication, tokens, scores."""
