"""Structured Streaming extensions (the profiled sources are batch tables)."""
