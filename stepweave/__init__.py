"""A Spark-native engine for procedural step graphs."""
