"""Access-log range analytics on Spark."""
