"""Spark-native keyword search and filtering over short texts, with versioned snapshots."""

__version__ = "0.1.0"
