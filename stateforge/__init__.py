"""A Spark-native engine for post-training data."""
