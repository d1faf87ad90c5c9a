"""Sources of the quote engine."""
