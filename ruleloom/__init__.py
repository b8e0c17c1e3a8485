"""Rule-driven content analytics as Spark DataFrame jobs."""
