"""linelake: a PySpark-native engine for 3-D line-segment analytics."""

__version__ = "0.1.0"
