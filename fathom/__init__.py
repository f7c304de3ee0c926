"""A Spark-native analytics engine for web and product events."""
