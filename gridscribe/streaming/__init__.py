"""Incremental serialization of arriving tables."""
