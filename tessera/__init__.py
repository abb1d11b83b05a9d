"""Spark-native research engine: time-series factors, point-in-time joins, strategies and data quality as DataFrame jobs."""
