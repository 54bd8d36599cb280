"""Bipartite temporal graph analytics as Spark DataFrame operators."""
