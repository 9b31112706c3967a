"""Spark-native analytics of message authorship and text corpora."""
