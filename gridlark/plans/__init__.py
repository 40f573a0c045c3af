"""Frames, ordered plans and SQL."""
