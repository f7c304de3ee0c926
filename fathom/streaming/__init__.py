"""Structured Streaming: ingestion of JSON lines, incremental pre-aggregates and sessions."""
