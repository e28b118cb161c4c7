"""Structured Streaming runners, sinks and live sources."""
