"""Column functions on text, arrays and vectors."""
