"""Functions of the text-alignment engine."""
