"""Operators on the text and vectors of training data. Nothing else in the library imports this package."""
