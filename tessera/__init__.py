"""Tessera: a PySpark-native analytics engine with explicit row order."""

__version__ = "0.1.0"
