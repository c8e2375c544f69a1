"""Supply-chain analytics jobs on Spark DataFrames."""
