"""A Spark-native engine for syntax-based opinion mining over annotated text."""
