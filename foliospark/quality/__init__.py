"""Constraints as queries for what breaks them, and schema changes as plans."""
