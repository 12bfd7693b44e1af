"""Spark-native retrieval, text analytics and corpus preparation."""
