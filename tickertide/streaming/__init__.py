"""Structured Streaming: ingest new headlines, and match and store them."""
