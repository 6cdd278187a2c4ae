"""Terrain and mountain-transport analytics on Spark DataFrames."""
