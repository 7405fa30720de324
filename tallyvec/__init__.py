"""Vector-search scoring of card transactions on Spark DataFrames."""
