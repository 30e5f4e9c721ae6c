"""Structured Streaming into a store, and a running view of latest values."""
