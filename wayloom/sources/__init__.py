"""Readers, writers and payload parsers."""
