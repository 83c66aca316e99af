"""Gneiss: Spark-native quality analytics for scientific archives and text corpora."""
