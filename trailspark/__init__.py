"""Evidence search and corpus preparation expressed with Spark DataFrames."""
