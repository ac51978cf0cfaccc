"""Session analytics over Spark DataFrames."""
