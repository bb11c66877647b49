"""Review analytics on Spark: a codebase, its calls and its reviews as DataFrames, and the questions asked of them."""
