"""folio_spark: a PySpark-native engine for document-page analytics."""

__version__ = "0.1.0"
