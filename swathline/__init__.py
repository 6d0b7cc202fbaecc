"""Coverage-route planning and vehicle telemetry on Spark DataFrames."""
