"""Composite queries and the catalog of them."""
