"""Structured Streaming forms of aggregations that keep up with arriving volumes."""
