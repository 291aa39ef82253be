"""Lookups, checks and measurements."""
