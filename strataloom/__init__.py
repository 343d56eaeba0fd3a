"""Spatial analytics over image planes, and their planning outputs, as Spark DataFrames."""
