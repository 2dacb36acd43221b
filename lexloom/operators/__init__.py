"""Operators of lexloom."""
