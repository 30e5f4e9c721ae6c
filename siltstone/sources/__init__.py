"""Stores on any Hadoop file system: segments, manifests, transactions, archives."""
