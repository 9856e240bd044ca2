"""A Spark-native engine for market event streams and their features."""
