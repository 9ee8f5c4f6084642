"""Scholarly-record linkage, verification and search on Spark DataFrames."""
