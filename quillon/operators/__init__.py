"""Distributed operators beyond Spark's built-in ones."""
