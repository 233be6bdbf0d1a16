"""A PySpark-native engine for geographic feature data in XML."""

__version__ = "0.1.0"
