"""Spark-native analytics of decision traces of automated agents."""

__version__ = "0.1.0"
