"""Corpus preparation jobs for source code and text, written as Spark DataFrame plans."""
