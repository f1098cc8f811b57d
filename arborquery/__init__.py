"""Spark-native search engine for file catalogs: find-style expressions over an entries table."""
