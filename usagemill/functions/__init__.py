"""Column functions: lenient casts, dates, names."""
