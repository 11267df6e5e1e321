"""Population synthesis and analysis on Spark DataFrames."""
