"""A PySpark-native engine for geo-referenced species-occurrence data."""
