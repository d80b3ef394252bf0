"""Corpus analytics on Spark: parameterised queries over text and code corpora."""
