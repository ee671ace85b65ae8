"""Expressions, order over ranges, tables between rounds."""
