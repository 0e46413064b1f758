"""A PySpark-native engine for versioned, deduplicated file catalogs."""
