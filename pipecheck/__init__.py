"""Find and repair broken table loads with Spark DataFrames."""
