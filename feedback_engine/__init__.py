"""A PySpark-native analytics engine for feedback, event and text collections."""
