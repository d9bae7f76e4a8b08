"""Spark-native analytics for electrical transformer telemetry."""
