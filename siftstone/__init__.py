"""A code-analysis dataflow engine on Spark DataFrames."""
