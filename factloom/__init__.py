"""Spark-native analytics over an ordered log of facts."""
