"""Readers: stored tables, the canonical log view, the wire format and live sources."""
