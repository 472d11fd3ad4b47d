"""Spark-native analytics for paired evaluation data."""
