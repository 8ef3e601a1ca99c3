"""Column functions: cleaning, units, geometry, dates, text forms."""
