"""Tessera: concept-annotated text analytics on PySpark."""
