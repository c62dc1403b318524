"""A PySpark-native engine that reports textual evidence over document tables."""

__version__ = "0.1.0"
