"""Column functions on frames."""
