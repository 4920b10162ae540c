"""A PySpark-native analytics engine for recording-style catalogues."""
