"""Structured Streaming ingest of document changes."""
