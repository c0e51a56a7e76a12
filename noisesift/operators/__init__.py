"""Shaping, joins, sampling, runs, weights and contrast (B-E, H-J)."""
