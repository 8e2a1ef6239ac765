"""Quarry: reference-data serving and analytics on PySpark."""
