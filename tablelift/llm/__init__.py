"""Operators over text corpora, each behind one function on DataFrames, and the queries that apply them."""
