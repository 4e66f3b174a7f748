"""Column functions on fixed-width arrays, and number generators."""
