"""Readers, schemas and adapters."""
