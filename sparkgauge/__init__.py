"""Spark-native analytics for evaluation records."""
