"""Dependency-graph and change-impact analytics on Spark DataFrames."""
