"""Incremental ingest: scheduled batches and Structured Streaming."""
