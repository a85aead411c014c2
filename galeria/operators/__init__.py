"""Operators over media catalogues, vectors, people and stored keys."""
