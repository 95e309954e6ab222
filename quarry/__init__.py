"""Spark-native analytics over source text, facts and document corpora."""
