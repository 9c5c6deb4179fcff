"""Spark-native analytics for image libraries."""
