"""Operators on line, point and embedding tables."""
