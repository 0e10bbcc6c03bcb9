"""Spark-native analytics for tiled-image detection data."""
