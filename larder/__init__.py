"""A Spark-native engine for retrieval, filtering and ranking."""
