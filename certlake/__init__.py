"""certlake: certificate analytics as Spark DataFrame jobs."""
