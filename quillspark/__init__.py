"""Spark-native analytics over editorial events and documents."""
