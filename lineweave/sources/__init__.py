"""Readers of line and level lists, and adapters from tables."""
