"""Tidewell: event analytics on Spark DataFrames."""
