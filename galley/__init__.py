"""Spark-native recipe and document analytics: extraction, classification, ranked inventory match."""
