"""Spark-native analytics over large collections of source code and text."""

__version__ = "0.1.0"
