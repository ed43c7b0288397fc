"""Readers with guards, and sinks with atomic publication."""
