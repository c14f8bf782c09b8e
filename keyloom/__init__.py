"""Spark-native retrieval over residual-quantised item keys, and the data processing around it."""

__version__ = "0.1.0"
