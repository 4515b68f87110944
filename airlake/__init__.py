"""Spark-native analytics and forecasting for hourly environmental series."""
