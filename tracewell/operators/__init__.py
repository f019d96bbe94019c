"""Operators of the text-alignment engine."""
