"""Structured Streaming forms of the polling dashboards."""
