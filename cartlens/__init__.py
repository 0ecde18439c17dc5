"""Retail behaviour analytics as Spark DataFrame operators."""
