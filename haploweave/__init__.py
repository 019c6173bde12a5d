"""Spark-native analytics for linkage blocks on weighted variant graphs."""

__version__ = "0.1.0"
