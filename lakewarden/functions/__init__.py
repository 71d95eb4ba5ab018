"""functions of the governed layer."""
