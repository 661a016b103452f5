"""Whole plans: the registered queries over stand-in tables, and reading real files."""
