"""Operators that prepare repository data for training language models."""
