"""surfaces of the governed layer."""
