"""Operators of a training-data pipeline: documents, pages and embeddings in, decisions out.

Every operator is a function from DataFrame to DataFrame in a module of its own; ``queries`` applies
each to its whole table. Nothing else in the library imports this package.
"""
