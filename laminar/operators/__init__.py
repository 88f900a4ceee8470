"""Operators over tables of boxes, rasters and vectors."""
