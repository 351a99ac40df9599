"""Queries over the test tables: derived views, the registry, and the same questions in SQL."""
