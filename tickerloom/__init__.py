"""Stock-news and sentiment analytics on Spark DataFrames."""
