"""A PySpark-native evidence retrieval and text-corpus engine."""
