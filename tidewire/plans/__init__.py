"""Whole queries over the star-schema tables, composed from the operators."""
