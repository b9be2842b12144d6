"""Column expressions over names, ratings, numbers, years and units."""
