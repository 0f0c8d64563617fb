"""loam: farm-sensor lake analytics as plain Spark DataFrame, SQL and streaming jobs."""
