"""Operators for training data and language-like text; nothing else in the library imports this."""
