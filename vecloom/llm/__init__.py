"""Operators of a training-data pipeline over documents, vectors, pages and conversations."""
