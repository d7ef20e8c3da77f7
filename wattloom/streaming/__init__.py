"""Structured Streaming forms of the windowing, joining, scoring and alerting operators."""
