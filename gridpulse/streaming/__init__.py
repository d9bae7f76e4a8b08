"""Structured Streaming forms (ST1-ST3)."""
