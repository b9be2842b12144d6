"""Readers of landed raw records and writers of tables."""
