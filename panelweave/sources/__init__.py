"""Readers, writers and inline tables."""
