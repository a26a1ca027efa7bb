"""Operators for training-data pipelines over documents, conversations and vectors.

Nothing else in the library imports this subpackage; ``queries.py`` registers one query per operator.
"""
