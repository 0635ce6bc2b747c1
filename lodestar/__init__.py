"""Spark-native knowledge-graph analytics: graphs and documents as DataFrames, every operation a DataFrame function."""
