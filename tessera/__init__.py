"""Tessera: a PySpark-native engine for scanning, pruning, inspecting and writing columnar Parquet data."""

__version__ = "0.1.0"
