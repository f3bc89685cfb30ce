"""Column functions: colour, numbers as text."""
