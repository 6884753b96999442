"""Structured Streaming forms of the stateful operators."""
