"""Event studies and market-data analytics on Spark DataFrames."""
