"""bitloom: lossless analysis of quantised tensors and corpus preparation on Spark DataFrames."""
