"""Prose and markup diagnostics over Spark DataFrames."""
