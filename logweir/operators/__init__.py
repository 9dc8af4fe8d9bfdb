"""Log operators."""
