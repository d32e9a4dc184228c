"""Structured Streaming forms of ingestion, dedup and question answering."""
