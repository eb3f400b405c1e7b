"""Lectern: timed-text analytics on Spark."""
