"""Compositions of operators and the query catalogue."""
