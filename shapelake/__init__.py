"""shapelake: a PySpark-native engine for image-abstraction tables and their evaluation data."""

__version__ = "0.1.0"
