"""vecloom: subspace quantization analytics on Spark DataFrames."""
