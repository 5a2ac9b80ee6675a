"""Manufacturing quality, flow and economics analytics on Spark DataFrames."""
