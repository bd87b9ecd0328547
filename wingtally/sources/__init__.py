"""Aerial survey analytics on Spark: sources."""
