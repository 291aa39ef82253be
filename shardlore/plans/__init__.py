"""Partition plans."""
