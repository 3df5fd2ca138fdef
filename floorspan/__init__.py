"""Indoor venue analytics on Spark."""
