"""Readers of tables, saved records and logs."""
