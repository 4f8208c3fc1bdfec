"""Spatial graph analytics and walking-route computation on Spark DataFrames."""
