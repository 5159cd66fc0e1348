"""Ratio studies, temporal validation and training-data preparation on Spark DataFrames."""
