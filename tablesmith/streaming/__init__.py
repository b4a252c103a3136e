"""Structured Streaming forms of the stateless plans, and windowed aggregates."""
