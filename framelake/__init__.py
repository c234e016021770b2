"""Spark jobs over raster, animation and timeline tables."""
