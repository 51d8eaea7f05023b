"""fundspark: a PySpark-native engine for fund time series and document retrieval."""

__version__ = "0.1.0"
