"""Spark-native analytics for text, vector and model data: DataFrame in, DataFrame out."""
