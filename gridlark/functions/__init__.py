"""Expressions, selectors and type names."""
