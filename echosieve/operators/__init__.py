"""Relational operators of the duplicate search."""
