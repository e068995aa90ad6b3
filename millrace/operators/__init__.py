"""Joins, windows, set operations and grouped aggregates that the DataFrame API has no single call for."""
