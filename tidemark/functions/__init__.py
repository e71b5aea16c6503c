"""Column functions and ordered-scan building blocks."""
