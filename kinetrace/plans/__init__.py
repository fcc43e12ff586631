"""Longer chains of operators, and the queries on the sample tables."""
