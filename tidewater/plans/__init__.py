"""Queries over the star-schema tables, each a plan of operators."""
