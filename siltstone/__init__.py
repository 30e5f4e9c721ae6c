"""Siltstone: a versioned key-value and range-scan engine on Spark DataFrames."""
