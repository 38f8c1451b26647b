"""Kindred: how close subject domains are to each other, measured with Spark DataFrames."""
