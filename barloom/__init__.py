"""A PySpark-native engine for panel time series."""
