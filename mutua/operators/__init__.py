"""Relational operators over trace tables."""
