"""Tessera: code-graph and text-clone analytics on Spark DataFrames."""
