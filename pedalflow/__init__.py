"""A PySpark-native engine for shared-bike availability and trip analytics."""
