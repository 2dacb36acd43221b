"""lexloom: corpus, tokenizer and evaluation analytics as Spark DataFrame plans."""
