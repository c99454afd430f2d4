"""Operators on cubes in long form."""
