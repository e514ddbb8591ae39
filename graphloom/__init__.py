"""Property graphs on Spark DataFrames."""
