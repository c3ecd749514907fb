"""Governed clinical lake on Spark DataFrames."""
