"""tallyforge: industrial telemetry analytics expressed as Spark DataFrame jobs."""
