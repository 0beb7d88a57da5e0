"""Spark-native analytics for collections of short texts attributed to groups of people."""

__version__ = "0.1.0"
