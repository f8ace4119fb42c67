"""Column functions: NA tokens, thresholds, rounding, and the p-value pandas UDFs."""
