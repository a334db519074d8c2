"""Structured Streaming forms of telemetry aggregation and run scoring."""
