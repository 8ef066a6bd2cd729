"""Air-quality telemetry analytics as Spark DataFrame transformations."""
