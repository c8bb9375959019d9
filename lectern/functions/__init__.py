"""Column functions and row-local operators on text."""
