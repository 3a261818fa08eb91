"""Queries over the driver tables, each with an independent SQL form for comparison."""
