"""Transforms of track tables: DataFrames in, DataFrames out."""
