"""Schemas, readers, writers and dimension tables."""
