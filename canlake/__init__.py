"""Spark-native analytics for CAN bus logs: frames in, DataFrames out."""
