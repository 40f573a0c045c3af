"""Windowed aggregates over streams."""
