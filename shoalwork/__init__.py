"""Spark-native campaign analytics over message-like records."""
