"""Spark-native analytics over annotated sequence data."""
