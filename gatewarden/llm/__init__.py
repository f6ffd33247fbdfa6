"""Operators for training data from language-model traffic. Nothing else in the library imports this."""
