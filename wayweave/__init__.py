"""Co-motion analytics on Spark."""
