"""folioflow: a PySpark-native engine for retrieval analytics over annotated document pages."""

__version__ = "0.1.0"
