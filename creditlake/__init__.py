"""Batch jobs for corporate credit ratings and company financials, as plain DataFrame code."""
