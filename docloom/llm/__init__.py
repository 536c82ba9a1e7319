"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. Every operator is a
``DataFrame -> DataFrame`` function; ``queries.py`` holds the thin queries that
apply each of them to its whole table.
"""
