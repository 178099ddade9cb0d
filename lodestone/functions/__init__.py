"""Column expressions: text, moments, similarity."""
