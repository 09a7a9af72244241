"""Scriptorium: a PySpark-native engine over note vaults and text corpora."""
