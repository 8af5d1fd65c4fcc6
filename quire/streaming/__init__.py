"""Structured Streaming forms of enrichment and rate limiting."""
