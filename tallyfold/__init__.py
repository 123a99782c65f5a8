"""Spark-native customer-activity forecasting: folds, features, models and blends as DataFrame jobs."""
