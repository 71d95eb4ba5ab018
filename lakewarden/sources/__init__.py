"""sources of the governed layer."""
