"""Streaming of the quote engine."""
