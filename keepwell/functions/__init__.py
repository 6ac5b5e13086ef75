"""Column helpers and distributed building blocks."""
