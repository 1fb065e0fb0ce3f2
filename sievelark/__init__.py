"""Data-quality and business-analytics operators on Spark DataFrames."""
