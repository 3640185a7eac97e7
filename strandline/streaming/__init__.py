"""Panel streaming."""
