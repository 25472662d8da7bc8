"""Connected-vehicle telemetry analytics written as Spark DataFrame transformations."""
