"""Page extraction, record unification and log analytics as Spark DataFrame jobs."""
