"""Structured Streaming forms of the append-only logs and of part routing."""
