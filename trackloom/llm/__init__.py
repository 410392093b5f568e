"""Operators on texts and vectors for training data. Nothing else in the library imports this subpackage."""
