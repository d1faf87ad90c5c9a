"""Operators of the quote engine."""
