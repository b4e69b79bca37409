"""Randomized linear algebra, kernel learning and local graph analysis on Spark DataFrames."""
