"""Spatial text alignment and corpus processing on Spark."""
