"""Column expressions: no shuffle, no action, safe in batch and in streams."""
