"""Incremental ingest (X1, X2) with Structured Streaming."""
