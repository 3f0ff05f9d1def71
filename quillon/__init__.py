"""Retrieval, ranking, graph and corpus analytics on Spark DataFrames."""
