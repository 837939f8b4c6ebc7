"""Evidence selection analytics on Spark."""
