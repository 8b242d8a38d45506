"""Relational and raster operators, each a DataFrame in, a DataFrame out."""
