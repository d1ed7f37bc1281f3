"""Storage inventory analytics as Spark DataFrame jobs."""
