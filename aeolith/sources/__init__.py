"""Readers, writers and proxy cubes."""
