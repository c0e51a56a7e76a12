"""The keyed contrastive bank in batch and Structured Streaming (J8, K)."""
