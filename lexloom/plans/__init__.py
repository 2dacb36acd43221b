"""Plans of lexloom."""
