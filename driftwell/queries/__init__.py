"""The query catalogue, by family."""
