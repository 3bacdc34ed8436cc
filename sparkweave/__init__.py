"""Spark-native co-expression and expression-variability analytics."""
