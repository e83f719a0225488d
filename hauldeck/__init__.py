"""Fleet trip analytics as Spark DataFrame jobs."""
