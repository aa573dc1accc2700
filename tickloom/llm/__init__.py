"""Operators for preparing training text. Nothing outside this package and the pipeline uses it."""
