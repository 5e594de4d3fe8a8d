"""Spark-native analytics over Markdown knowledge bases and document tables."""

__version__ = "0.1.0"
