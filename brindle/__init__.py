"""Spark-native text, vector, graph and signal analytics."""
