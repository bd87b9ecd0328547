"""Aerial survey analytics on Spark: functions."""
