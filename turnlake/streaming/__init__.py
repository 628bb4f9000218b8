"""Structured Streaming forms of the append-and-fold operators."""
