"""lodewright: code-intelligence analytics on Spark DataFrames."""
