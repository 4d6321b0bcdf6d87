"""Quarry: a PySpark-native engine for benchmark construction and corpus preparation."""
