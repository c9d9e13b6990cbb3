"""Retail star-schema analytics on Spark."""
