"""Spark-native drift, outlier, series, association and diagnostic operators."""
