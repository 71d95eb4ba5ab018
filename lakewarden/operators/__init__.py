"""operators of the governed layer."""
