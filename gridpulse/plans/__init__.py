"""Whole plans: the telemetry frame, the stand-in feeds and the registered queries."""
