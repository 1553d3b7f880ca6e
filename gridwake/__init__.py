"""Spark-native analytics of gridded density data."""
