"""Quoin: a PySpark-native engine for evaluating text extraction and drawing geometry."""
