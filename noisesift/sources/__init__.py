"""Readers and writers (A)."""
