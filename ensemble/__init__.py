"""Ensemble analytics on Spark: sampling, feature extraction, validation, exploration, models."""
