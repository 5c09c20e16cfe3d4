"""Relational operators: overlaps, sparse matrices, elevation classes, topography, merging."""
