"""Operators for training data, queries and SQL included.

Nothing outside this subpackage imports it.
"""
