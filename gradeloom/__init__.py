"""Spark-native weak-label, rank-metric and ensemble analytics."""
