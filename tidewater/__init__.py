"""Spark-native analytics library: typed Column and DataFrame operators."""
