"""Panel sources."""
