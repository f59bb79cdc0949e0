"""Spark-native analytics for versioned, hierarchical legal text."""
