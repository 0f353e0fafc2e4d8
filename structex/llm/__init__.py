"""Operators of a large training-data pipeline. Nothing else in the library imports this."""
