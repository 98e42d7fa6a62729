"""Event analytics and fraud scoring as Spark DataFrame jobs."""
