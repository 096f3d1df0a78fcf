"""Continuous scoring of requests with Structured Streaming."""
