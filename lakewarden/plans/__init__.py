"""plans of the governed layer."""
