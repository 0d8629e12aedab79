"""Comparison operators on pairs of tables."""
