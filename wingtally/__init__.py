"""Aerial wildlife survey analytics, declared as Spark DataFrame plans."""
