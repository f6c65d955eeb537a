"""A Spark-native engine for investigative analytics over case-style relational tables."""
