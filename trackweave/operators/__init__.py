"""Operators on tracks, track points and clusters: DataFrames in, DataFrames out."""
