"""Operators for building training data from large text, page and vector tables."""
