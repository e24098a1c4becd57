"""Windowed aggregations that read a table or a stream."""
