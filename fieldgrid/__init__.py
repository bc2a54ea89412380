"""Gridded measurement analytics as Spark DataFrame operators."""
