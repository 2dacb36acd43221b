"""Functions of lexloom."""
