"""vertexloom: full-batch graph neural-network analytics on Spark DataFrames."""
