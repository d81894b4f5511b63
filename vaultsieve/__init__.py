"""Spark-native credential-leak analytics."""

__version__ = "0.1.0"
