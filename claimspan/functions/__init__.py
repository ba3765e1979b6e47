"""Column functions: calendar dates, business days and exact rounding."""
