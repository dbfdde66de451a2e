"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and their DuckDB equivalents.
"""
