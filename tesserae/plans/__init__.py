"""Queries over the driver tables; see ``registry.all_queries()``."""
