"""quarry: sequence-pattern analytics on Spark DataFrames."""
