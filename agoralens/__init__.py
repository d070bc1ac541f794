"""Batch and streaming analytics over text posts, written on PySpark."""
