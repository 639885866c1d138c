"""Functional analysis of 24-hour cyclic curve data on Spark DataFrames."""
