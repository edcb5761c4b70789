"""Spark-native analytics over multivariate traces."""
