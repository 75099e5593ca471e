"""Sequence-state analytics on PySpark."""
