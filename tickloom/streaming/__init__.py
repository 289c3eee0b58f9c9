"""Structured Streaming versions of ingest, cleaning, windows and scaling."""
