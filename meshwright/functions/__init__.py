"""Scalar functions as columns: geometry, projections, indexing, units."""
