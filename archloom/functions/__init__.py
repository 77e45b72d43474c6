"""Column expressions: URLs, text, dates."""
