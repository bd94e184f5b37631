"""Streaming of the co-motion engine."""
