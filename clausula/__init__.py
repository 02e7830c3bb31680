"""A PySpark-native engine for typed data contracts."""
