"""Market and location analytics as Spark DataFrame jobs."""
