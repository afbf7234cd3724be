"""A Spark-native engine for market-microstructure analytics."""
