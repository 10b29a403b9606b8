"""tunelake: database-tuning telemetry analytics as PySpark jobs."""
