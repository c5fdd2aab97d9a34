"""Transcript evaluation on Spark."""
