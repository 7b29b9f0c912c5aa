"""Marlspring: literature mining and catalog analytics as PySpark DataFrame operators."""
