"""Account-similarity analytics on Spark DataFrames."""
