"""Spark-native analytics for per-part sensor and image time series."""
