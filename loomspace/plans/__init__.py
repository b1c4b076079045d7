"""Whole plans: build, retrieval, and the catalogue of queries."""
