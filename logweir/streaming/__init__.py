"""Log streaming."""
