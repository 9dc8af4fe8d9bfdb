"""Log analytics on Spark DataFrames: sources, parsers, row construction, queries, streaming."""
