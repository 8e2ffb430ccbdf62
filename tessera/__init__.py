"""Raster and image-container analytics on Spark DataFrames."""
