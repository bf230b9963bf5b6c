"""Operators for large training-corpus pipelines.

Nothing outside this subpackage imports it; ``queries.py`` here holds its
registered queries and their SQL.
"""
