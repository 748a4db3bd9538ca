"""Queries that bind operators to the driver tables, each with its SQL."""
