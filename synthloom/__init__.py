"""Spark-native building blocks for instruction-tuning datasets."""
