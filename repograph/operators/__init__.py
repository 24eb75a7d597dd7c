"""Joins, cascades, folds and rankings."""
