"""Document, graph and evaluation analytics on Spark DataFrames."""
