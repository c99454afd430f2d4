"""Streaming forms of the cube operators."""
