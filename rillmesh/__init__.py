"""A Spark-native engine for rule-based data exchange, provenance and reconciliation."""

__version__ = "0.1.0"
