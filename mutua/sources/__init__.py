"""Readers and writers of trace tables."""
