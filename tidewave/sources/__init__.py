"""Readers, writers, declared schemas and the mapping from the given tables."""
