"""Spatial co-occurrence analytics as DataFrame-to-DataFrame operators on Spark."""
