"""Operators of a training-data pipeline over documents, pages, labels and a benchmark.

Nothing else in the package imports this folder. Every operator states in its docstring what
it does with nulls, empty texts, ties, repeated rows and empty tables.
"""
