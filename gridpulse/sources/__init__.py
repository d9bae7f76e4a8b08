"""Readers (S1-S5) and writers."""
