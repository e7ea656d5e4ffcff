"""The catalogue of editorial queries. ``registry.CATALOGUE`` has them by code."""
