"""Operators for the text of language-model training data. Nothing outside this folder imports it."""
