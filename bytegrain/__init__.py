"""bytegrain: byte-level corpus analytics on Spark DataFrames."""
