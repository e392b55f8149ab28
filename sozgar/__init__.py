"""Spark-native analytics for Uzbek text and dictionary building."""

__version__ = "0.1.0"
