"""Spark-native text analytics: document preparation, retrieval, knowledge
graphs and evaluation as DataFrame operators."""

__version__ = "0.1.0"
