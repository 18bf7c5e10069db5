"""Stateless parsing of lines that arrive as a stream."""
