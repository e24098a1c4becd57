"""Readers, and tables that cut lineage."""
