"""Log sources."""
