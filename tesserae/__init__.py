"""tesserae: a Spark-native analytics engine for versioned text, code and activity data."""

__version__ = "0.1.0"
