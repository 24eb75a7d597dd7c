"""Incremental indexing."""
