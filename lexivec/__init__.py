"""Spark-native building, searching and evaluating of text-embedding corpora."""
