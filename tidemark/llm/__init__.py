"""Operators on texts and numbers for training data."""
