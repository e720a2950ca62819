"""gridscribe: Spark-native table-to-passage serialization and retrieval analytics."""
