"""Sources of the editorial tables."""
