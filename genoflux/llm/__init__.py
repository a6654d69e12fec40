"""Operators for large training-data corpora, each a Spark job of its own.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL.
"""
