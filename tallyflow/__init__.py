"""Spark-native statistics of symbol sequences: streams, contexts, profiles, codelengths."""
