"""Spark-native analytics for reasoning-trace and training-data tables."""
