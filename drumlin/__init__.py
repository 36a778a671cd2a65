"""Density-based cluster analysis on Spark DataFrames."""

__version__ = "1.0.0"
