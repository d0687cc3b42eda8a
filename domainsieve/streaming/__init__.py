"""Structured Streaming: time-to-live admission and the query path on a live log."""
