"""Operators over canonical stack tables."""
