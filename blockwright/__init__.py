"""Spark-native block analytics and adaptive storage planning."""

__version__ = "0.1.0"
