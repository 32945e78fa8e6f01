"""Structured Streaming forms of the engine's continuous work."""
