"""Spark-native analytics over an encyclopedia-like knowledge corpus."""
