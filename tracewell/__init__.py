"""Tracewell: a PySpark-native engine that traces statements back to source sentences."""
