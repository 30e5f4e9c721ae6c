"""Bloom filters and the order-preserving key codec."""
