"""Lexical and learning-data analytics as PySpark queries."""
