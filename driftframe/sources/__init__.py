"""Readers, writers and generators of drives and road maps."""
