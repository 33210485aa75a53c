"""Operators for preparing text corpora (training data) at scale."""
