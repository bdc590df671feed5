"""Electricity-meter telemetry on Spark: ingestion, a readings table and time-bucketed queries."""
