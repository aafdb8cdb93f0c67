"""Operators for cleaning and encoding large training corpora."""
