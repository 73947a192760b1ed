"""Readers, writers, schemas and fixed dimension rows."""
