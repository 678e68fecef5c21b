"""Gradeloom: a PySpark-native analytics engine for free-text assessment data."""

__version__ = "0.1.0"
