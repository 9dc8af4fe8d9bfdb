"""Log functions."""
