"""Operators for large training-data corpora, on PySpark.

Nothing else in the library imports this subpackage.
"""
