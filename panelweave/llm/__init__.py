"""Operators for preparing large text collections: rules, deduplication, mixing, tokenizing, archives, filters."""
