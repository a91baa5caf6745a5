"""Registered queries over the given tables, with their independent SQL."""
