"""Search, ranking and clustering of linked, described and sequenced parts, as Spark DataFrames."""
