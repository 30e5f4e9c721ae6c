"""Operators over logs: pure functions from DataFrames to DataFrames."""
