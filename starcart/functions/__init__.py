"""starcart."""
