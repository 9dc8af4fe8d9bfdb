"""Query plans over log tables."""
