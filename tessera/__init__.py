"""Tessera: a PySpark-native analytics engine for tracked-object data and text corpora."""
