"""Structured Streaming versions: exports, rule scan, heartbeats, debounce."""
