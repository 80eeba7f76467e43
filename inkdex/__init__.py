"""A Spark-native full-text retrieval and ranking engine with operators for large text tables."""
