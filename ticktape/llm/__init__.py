"""Operators and a pipeline for training text.  Nothing else in the library imports this package."""
