"""Spark-native operators for detection, review, label and map-evidence tables."""
