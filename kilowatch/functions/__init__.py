"""Column functions: time axis, rounding, message parsing."""
