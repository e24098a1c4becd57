"""Point-in-time research data, valuation kernels and signal statistics on Spark DataFrames."""
