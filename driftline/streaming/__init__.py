"""Operators on streaming DataFrames, and sinks for them."""
