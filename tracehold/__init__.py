"""Host-log provenance analytics as Spark DataFrame jobs."""
