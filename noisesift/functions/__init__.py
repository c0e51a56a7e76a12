"""Column helpers for texts and vectors, and metrics (F, G)."""
