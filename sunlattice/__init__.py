"""Solar exposure of height grids, and the queries around it, on Spark DataFrames."""
