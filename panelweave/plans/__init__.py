"""Queries over the star-schema tables, built from the operators."""
