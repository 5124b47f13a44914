"""Retail sales and churn analytics as lazy Spark DataFrame operators."""

from martlens.sources.tables import RetailTables

__all__ = ["RetailTables"]
