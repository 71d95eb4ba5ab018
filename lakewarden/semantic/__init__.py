"""semantic of the governed layer."""
