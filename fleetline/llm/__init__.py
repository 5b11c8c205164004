"""Operators for building training corpora: ten text operators and the queries that apply them."""
