"""Structured Streaming into chunked tables."""
