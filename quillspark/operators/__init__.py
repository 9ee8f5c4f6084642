"""Similarity, merging and verification operators on DataFrames."""
