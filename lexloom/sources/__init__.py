"""Sources of lexloom."""
