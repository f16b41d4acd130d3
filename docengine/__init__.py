"""Spark-native document analytics: chunking, hybrid retrieval, reports."""
