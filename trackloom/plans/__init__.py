"""Query plans over the provided tables."""
