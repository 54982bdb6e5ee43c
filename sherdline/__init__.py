"""Fragment-collection analytics as Spark DataFrame jobs."""
