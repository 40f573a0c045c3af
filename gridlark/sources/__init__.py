"""Readers: every source becomes a lazy DataFrame."""
