"""Operators for large text corpora, their queries and SQL; nothing else in the library imports this."""
