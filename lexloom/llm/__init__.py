"""Training-data operators for very large corpora; nothing else in the package imports this."""
