"""Spark-native analytics of sampled reasoning traces."""
