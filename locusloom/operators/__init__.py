"""Operators over canonical tables: DataFrames in, DataFrame out."""
