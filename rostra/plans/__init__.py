"""Composed queries, and the catalogue of registered queries with their SQL."""
