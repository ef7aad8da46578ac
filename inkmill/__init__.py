"""Spark-native corpus building, auditing and scoring."""
