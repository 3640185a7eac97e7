"""Panel operators."""
