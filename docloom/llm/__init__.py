"""Operators of a training-data pipeline over tables of documents, pages and
vectors. Nothing else in the library imports this subpackage."""
