"""Feeds in, records out."""
