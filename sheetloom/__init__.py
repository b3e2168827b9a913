"""Spark-native analytics over spreadsheet cells and document words."""
