"""Pairwise record matching, and training-data operators, on Spark DataFrames."""
