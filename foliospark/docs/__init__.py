"""Transforms of documents and their blocks."""
