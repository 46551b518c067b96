"""Spark-native hybrid retrieval, page-graph analytics and corpus preparation."""

__version__ = "0.1.0"
