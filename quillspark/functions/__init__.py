"""Column expressions: text, lexicons, scores."""
