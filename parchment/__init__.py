"""Parchment: document-corpus analytics on PySpark."""
