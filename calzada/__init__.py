"""Urban traffic analytics as plain Spark jobs."""
