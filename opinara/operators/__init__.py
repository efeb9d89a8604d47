"""Relational operators: each takes a DataFrame and returns a DataFrame."""
