"""Spark-native analytics for tiled microscopy quality control."""
