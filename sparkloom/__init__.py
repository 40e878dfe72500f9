"""PySpark-native analytics engine for conversation and activity data."""
