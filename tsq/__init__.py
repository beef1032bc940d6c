"""tsq: a PySpark-native engine for time-series metrics."""
