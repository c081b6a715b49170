"""Retail sales analytics, prediction, forecasting and table expansion on Spark."""
