"""Transaction-monitoring analytics on Spark."""
