"""A typed property-graph engine on Spark DataFrames."""
