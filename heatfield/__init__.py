"""Spatial event analytics on Spark."""
