"""A composable query language, entity layer and data tools that run on Spark DataFrames."""
