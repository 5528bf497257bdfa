"""Spark-native analytics over byte sources, findings and text corpora."""
