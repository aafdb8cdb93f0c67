"""Loomspan: pattern queries over annotated text, run as Spark DataFrame plans."""
