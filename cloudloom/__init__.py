"""Point-cloud and text-corpus queries on Spark DataFrames."""
