"""recallspark: similarity search, entity memory and corpus preparation on Spark DataFrames."""
