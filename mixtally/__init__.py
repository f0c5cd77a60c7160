"""Mixture quantification and corpus processing on PySpark."""
