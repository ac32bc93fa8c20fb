"""A Spark-native engine for single-cell droplet experiments."""
