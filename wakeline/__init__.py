"""Vessel-track analytics on Spark."""
