"""Operators for training-data preparation, written as Spark jobs.

Each module holds one operator with its own general interface; ``queries.py``
holds the thin contract queries.  Nothing else in the library imports this
subpackage.
"""
