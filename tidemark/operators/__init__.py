"""Operators on keyed, ordered tables."""
