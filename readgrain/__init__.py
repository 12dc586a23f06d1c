"""readgrain: a PySpark-native engine for text-readability and generated-text quality data."""

__version__ = "0.1.0"
