"""codeweft: a Spark-native engine for typed knowledge graphs extracted from source code."""

__version__ = "0.1.0"
