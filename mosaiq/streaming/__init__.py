"""Structured Streaming forms of the time-series operators."""
