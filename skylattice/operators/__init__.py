"""Operators over maps, catalogs and events: DataFrames in, DataFrames out."""
