"""Operators for large-scale training data, and the queries that apply them."""
