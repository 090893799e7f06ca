"""Spark-native engine for event-time condition monitoring and training-data upkeep."""

__version__ = "0.1.0"
