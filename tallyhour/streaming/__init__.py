"""Structured Streaming queries around the same operators."""
