"""Operators over the graph's DataFrames."""
