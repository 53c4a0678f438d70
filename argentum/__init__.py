"""A PySpark-native engine for image-file metadata, pixel relations and parameter tables."""
