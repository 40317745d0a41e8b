"""Whole runs over the domain tables, and the checks on the star-schema tables."""
