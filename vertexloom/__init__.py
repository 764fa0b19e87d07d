"""Locality analytics for sparse matrices and directed graphs, on Spark DataFrames."""
