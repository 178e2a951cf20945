"""Behavioural-data preparation, scoring and evaluation on Spark DataFrames."""
