"""A Spark-native engine for corpora of equations, training cases and texts."""

__version__ = "0.1.0"
