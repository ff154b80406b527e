"""Operators on DataFrames: frequency lists and ranks."""
