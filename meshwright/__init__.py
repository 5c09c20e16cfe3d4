"""Sparse conservative regridding, elevation classes and model coupling as Spark DataFrames."""
