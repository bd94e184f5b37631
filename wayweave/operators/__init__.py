"""Operators of the co-motion engine."""
