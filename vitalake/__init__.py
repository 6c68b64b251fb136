"""Profile-data operators on Spark DataFrames."""
