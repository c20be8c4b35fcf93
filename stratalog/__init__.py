"""Spark-native analytics over packed binary assets, their logs and archives."""
