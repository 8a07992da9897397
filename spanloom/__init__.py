"""Transcript and interval analytics on PySpark."""
