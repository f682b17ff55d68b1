"""Registered queries over the provided tables, with their SQL oracles."""
