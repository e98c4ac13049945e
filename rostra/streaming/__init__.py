"""Incremental ingest and day counts with Structured Streaming."""
