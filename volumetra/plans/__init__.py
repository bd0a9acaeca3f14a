"""Fixtures on the supplied tables, and the catalogue of queries with their SQL."""
