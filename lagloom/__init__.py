"""Causal-network analytics on Spark: panels, lagged moments, edges, roles."""
