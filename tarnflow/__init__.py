"""A PySpark-native engine for rainfall-runoff and flood analytics on gridded terrain."""
