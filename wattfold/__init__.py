"""Meter-telemetry analytics as Spark DataFrame operators."""
