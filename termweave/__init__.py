"""Closure-aware association analytics on Spark DataFrames."""
