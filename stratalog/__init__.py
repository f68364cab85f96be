"""Stratalog: a PySpark-native hybrid transactional/analytical engine over an append-only change log."""

__version__ = "0.1.0"
