"""terracell: grid exposure, damage and network risk analytics on Spark DataFrames."""
