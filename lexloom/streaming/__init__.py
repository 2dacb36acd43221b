"""Streaming of lexloom."""
