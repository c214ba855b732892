"""Broadsheet: daily-news analytics on Spark DataFrames."""
