"""Spark-native preparation, rewriting and evaluation of code-change / message corpora."""
