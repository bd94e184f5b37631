"""Plans of the co-motion engine."""
