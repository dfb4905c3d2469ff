"""util."""
