"""Spark-native analytics over board-position evaluations, plus training-data operators in ``llm``."""
