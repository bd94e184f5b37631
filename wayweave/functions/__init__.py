"""Functions of the co-motion engine."""
