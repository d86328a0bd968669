"""strandflow: a PySpark-native engine for large tables of symbolic sequences and their scores."""

__version__ = "0.1.0"
