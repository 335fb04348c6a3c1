"""A PySpark-native analytics engine for content, commerce, booking and search data."""
