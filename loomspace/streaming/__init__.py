"""Incremental building of a registry from a stream."""
