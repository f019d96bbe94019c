"""Plans of the text-alignment engine."""
