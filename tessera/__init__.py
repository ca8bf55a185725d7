"""Retrieval analytics on Spark."""
