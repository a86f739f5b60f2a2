"""Readers of tables and of semi-structured text."""
