"""Operators for preparing training corpora, one module each, and the queries that apply them."""
