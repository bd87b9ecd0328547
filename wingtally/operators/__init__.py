"""Aerial survey analytics on Spark: operators."""
