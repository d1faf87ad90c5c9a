"""Bidloom: quote matching and price analytics as PySpark DataFrame jobs."""
