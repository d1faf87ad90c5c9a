"""Functions of the quote engine."""
