"""Spark-first analytics for low-channel biosignal time series."""
