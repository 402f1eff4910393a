"""Causal text analytics on Spark."""
