"""Spark-native analytics over source-code repositories."""
