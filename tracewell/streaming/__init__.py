"""Streaming of the text-alignment engine."""
