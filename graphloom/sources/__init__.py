"""Readers and writers of the portable files."""
