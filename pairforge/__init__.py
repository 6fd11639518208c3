"""Spark-native engine for text-pair matching and its evaluation."""
