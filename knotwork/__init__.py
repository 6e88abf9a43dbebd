"""knotwork: knowledge-graph analytics over plain Spark DataFrames."""
