"""Spark-native analytics over edge records, and preparation of training data."""
