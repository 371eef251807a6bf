"""leafweave: a Spark-native engine for document evidence graphs."""

__version__ = "0.1.0"
