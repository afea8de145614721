"""Mergeable set summaries on Spark DataFrames."""
