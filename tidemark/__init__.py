"""Market, event and news analytics on Spark DataFrames."""
