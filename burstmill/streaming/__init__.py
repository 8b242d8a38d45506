"""Structured Streaming forms of the pair generator."""
