"""Operators of a training-data pipeline over tables of texts and vectors.

Nothing else in the library imports this subpackage.
"""
