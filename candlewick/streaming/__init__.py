"""Structured Streaming operators for live bars."""
