"""Time series and versioned key-value analytics on Spark DataFrames."""
