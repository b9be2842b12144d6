"""Joins, windows, merges, clean-up and reports over the four tables."""
