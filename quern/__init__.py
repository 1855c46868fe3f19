"""quern: retrieval, telemetry and training-data operators as Spark DataFrame transformations."""
