"""Spark-native panel analytics."""
