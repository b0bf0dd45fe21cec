"""Raster analytics on Spark: image containers, pixels and samples as DataFrames."""
