"""Operators on the link graph."""
