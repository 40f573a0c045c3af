"""Operators that run on rows: paging, values, charts, statistics."""
