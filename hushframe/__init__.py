"""hushframe: find, mask and restore sensitive values in Spark DataFrames."""
