"""Spark-native financial text signals."""
