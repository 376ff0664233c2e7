"""Queries over the given tables, and reports."""
