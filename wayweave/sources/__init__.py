"""Sources of the co-motion engine."""
