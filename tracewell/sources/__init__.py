"""Sources of the text-alignment engine."""
