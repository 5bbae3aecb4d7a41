"""Structured Streaming around the batch engine."""
