"""Spark-native analytics over genome sequencing tables."""
