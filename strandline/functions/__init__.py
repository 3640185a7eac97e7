"""Panel functions."""
