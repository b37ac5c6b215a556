"""Spark-native engine for evidence synthesis."""
